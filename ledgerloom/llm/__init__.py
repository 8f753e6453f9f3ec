"""Operations of a large-scale training-data pipeline, expressed as Spark jobs."""
