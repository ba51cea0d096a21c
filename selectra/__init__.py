"""Selectra: choosing between candidate configurations from measured outcomes, on Spark.

The vocabulary is neutral: an *entity* is measured in several *contexts* with
several *candidates*; every measurement is a *replicate*.  A *case* is one
(entity, context, budget) for which one feasible candidate has to be chosen.
"""
