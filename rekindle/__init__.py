"""rekindle — purchase re-interest analytics as Spark DataFrame jobs.

Vocabulary used throughout the package:

* *anchor*  — a row (user_id, category, event_ts) to be scored,
* *event*   — (user_id, item_id, event_ts, event_type, leaf/mid/top ids, amount),
* *level*   — leaf, mid or top of the category tree,
* *window*  — the N calendar days before the anchor's day.
"""
