"""Where logs come from and go to: the store, byte logs, typed rows."""
