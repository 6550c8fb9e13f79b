"""pairsight: paired evaluation statistics and corpus operators on PySpark."""
