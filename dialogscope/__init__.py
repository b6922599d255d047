"""dialogscope — Spark-native analytics over tables of tutoring dialogs.

Funnels, daily/monthly counts, session statistics, class roll-ups, tag
reports and dialog-skeleton parsing, all as lazy DataFrame plans.
"""

__version__ = "0.1.0"
