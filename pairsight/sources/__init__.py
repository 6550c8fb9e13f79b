"""Part of pairsight: sources."""
