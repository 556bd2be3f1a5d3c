"""pliego: a Spark-native bulk document-generation (mail-merge) pipeline.

Messages (nested JSON) are parsed, validated and flattened into one row per
requested document, joined to a template table, bound, rendered by templates
compiled into Catalyst expressions, written to a date-partitioned store, and
folded back into the original messages. Every step is a DataFrame -> DataFrame
or Column -> Column function.
"""

__version__ = "0.1.0"
