"""Part of the library; see the README for what is where."""
