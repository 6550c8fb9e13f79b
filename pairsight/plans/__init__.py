"""Part of pairsight: plans."""
