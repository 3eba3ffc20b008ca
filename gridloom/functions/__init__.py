"""Part of gridloom: functions."""
