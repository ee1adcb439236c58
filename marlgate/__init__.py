"""marlgate: a PySpark-native engine for market research data.

Layers: ``sources`` (table registry, reads, writes, generations), ``functions`` (column helpers), ``plans``
(expression compiler, query catalogue), ``operators`` (data-processing operators), ``streaming``.
The optional subpackage ``llm`` holds the operators on free text; nothing here imports it.
"""

__version__ = "0.1.0"
