"""talkloom sources."""
