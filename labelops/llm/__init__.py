"""Operators of a training-data pipeline over ``documents``: dedup, quality, toxicity, token counts,
decontamination, packing, sharding and language identification."""
