"""Jobs over the library: each a function that takes a session, with a command line and a small config file."""
