"""The statements: functions from tables and parameters to a DataFrame."""
