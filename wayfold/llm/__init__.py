"""Operations of a training-data pipeline, each built on Spark."""
