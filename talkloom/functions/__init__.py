"""talkloom functions."""
