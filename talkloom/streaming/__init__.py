"""talkloom streaming."""
