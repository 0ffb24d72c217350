"""leakscope: label-audit analytics expressed as Spark DataFrame plans.

The package turns nested object records into one row per object, cleans them
with a full drop accounting, derives features, and measures how much of a
rule-based label survives once the label-defining columns are removed.
Every operator is a DataFrame transformation; nothing is collected to the
driver except bounded metadata (edges, model specs, small result rows).
"""

__version__ = "0.1.0"
