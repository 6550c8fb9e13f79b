"""Part of pairsight: functions."""
