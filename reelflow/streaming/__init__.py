"""Change streams that feed the batch operators through `foreachBatch`."""
