"""Training-data operators: quality, decontamination, extraction, PII, packing,
sharding, toxicity, language-model scoring, near-duplicates and licences.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds
``registry.QUERIES`` when the folder is present.
"""
