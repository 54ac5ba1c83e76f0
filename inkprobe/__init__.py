"""inkprobe: human-versus-machine text analytics as Spark jobs.

The package is organised by what a Spark user touches first:

* ``sources``    labelled corpora, result tables, feature cache, saved models
* ``functions``  column expressions (text cleaning, distribution metrics, prompts)
* ``operators``  DataFrame -> DataFrame steps (sampling, counting, joins, metrics)
* ``plans``      classifiers, evaluation harnesses, strategies, whole experiments
* ``catalog``    the queries checked against a second SQL engine
"""

__version__ = "0.1.0"
