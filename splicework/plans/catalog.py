"""All queries of the library and their SQL."""

from splicework.plans import clock_queries, edit_queries, grade_queries, media_queries, pick_queries, queries, reading_queries, scalar_queries, sound_queries, stream_queries, track_queries, word_queries  # noqa: F401

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
