"""Operators: functions DataFrame -> DataFrame (and MLlib stages)."""
