"""Part of gridloom: operators."""
