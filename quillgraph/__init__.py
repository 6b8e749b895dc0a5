"""quillgraph: document and knowledge-graph analytics on PySpark.

Sub-packages: ``functions`` (Column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and keyed stores), ``streaming``
(Structured Streaming), ``plans`` (the registered queries and their SQL) and
``llm`` (corpus preparation; nothing else imports it).
"""

__version__ = "0.1.0"
