"""The dialect has no streams, watermarks or time windows, so there are no streaming operators.

A streaming DataFrame can still be a table of a session: statements without
ORDER BY, LIMIT and set operators plan on it as on any other.
"""
