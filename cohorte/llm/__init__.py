"""Training-data operators: extraction, near-duplicates, personal data,
toxicity, mixing, quality, licences, secrets, nearest neighbours and
benchmark decontamination.

Nothing outside this subpackage imports it; ``catalog`` registers its
queries. Modules are imported by Spark's Python workers, so the package
must be on their path (``--py-files`` or an installed wheel).
"""
