"""evenfold: deterministic evidence reduction over noisy documents, on Spark.

Core subpackages: ``functions`` (column expressions and small kernels),
``operators`` (DataFrame to DataFrame), ``sources`` (readers and sinks),
``streaming`` (event replay), ``plans`` (registered queries and their SQL).
The subpackage ``llm`` holds the text operators for training corpora; nothing
else imports it.
"""
