"""Training-data operators. Nothing outside this folder imports it, except the guarded entry module."""
