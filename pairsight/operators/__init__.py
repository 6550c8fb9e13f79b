"""Part of pairsight: operators."""
