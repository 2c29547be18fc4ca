"""tidelog: log and event pipelines as Spark DataFrame transformations."""
