"""Part of skein: functions."""
