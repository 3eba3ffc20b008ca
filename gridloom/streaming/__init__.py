"""Part of gridloom: streaming."""
