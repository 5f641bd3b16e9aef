"""quadweave: RDF data fusion and conflict resolution as Spark DataFrame plans."""

__version__ = "0.1.0"
