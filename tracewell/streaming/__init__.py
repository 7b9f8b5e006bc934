"""Pages that arrive over time: the assessment keeps no state, so the batch expressions run on streams as they are."""
