"""The limit that scans are held to."""

#: Bytes that one scan may read unless told otherwise.
BUDGET = 5 * 10**9
