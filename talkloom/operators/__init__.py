"""talkloom operators."""
