"""Every registered query of the library itself."""

from marquee.plans import benchmark, candidates, categories, core, evaluation, features, gates, ingest, models, ranker, records, runs, streams, training, variants
from marquee.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "benchmark", "candidates", "categories", "core", "evaluation", "features", "gates", "ingest", "models", "ranker", "records", "runs", "streams", "training", "variants"]
