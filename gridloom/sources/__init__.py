"""Part of gridloom: sources."""
