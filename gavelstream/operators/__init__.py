"""DataFrame-to-DataFrame operators; each states what it costs at a hot key."""
