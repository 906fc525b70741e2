"""talkloom plans."""
