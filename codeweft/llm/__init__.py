"""Training-data operators: quality, packing, sharding, near duplicates, HTML, chat, decontamination,
token counts, toxicity and nearest neighbours. Nothing else in the library imports this subpackage."""
