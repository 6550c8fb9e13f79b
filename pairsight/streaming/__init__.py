"""Part of pairsight: streaming."""
