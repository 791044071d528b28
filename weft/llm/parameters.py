"""Production parameters that the queries and the pipeline share."""

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Shares of tokens by language that the mixture aims at.
TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}
#: Most labelled documents that teach the mixture its domains.
LABELLED = 3000
