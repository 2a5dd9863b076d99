"""Spark operators for recorded market tapes, bars, transcripts and prediction replay."""
