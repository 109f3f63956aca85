"""Operations of a large training-data pipeline.  Nothing outside this package imports it."""
