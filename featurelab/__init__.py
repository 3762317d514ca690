"""featurelab: Spark-native data operators for image-generation model pipelines.

Subpackages
-----------
functions  column expressions (paths, rng, vectors, image geometry, formatting)
operators  DataFrame -> DataFrame operators (positions, distances, statistics,
           metrics, labels, alignment, sampling, scoring)
sources    file scans (image folders, archives, array artifacts, manifests)
sinks      dataset / manifest / report writers
plans      end-to-end compositions over the driver tables (fixtures, evaluate)
streaming  Structured Streaming forms of the metric and encoding jobs
"""

__version__ = "0.1.0"
