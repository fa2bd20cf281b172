"""Operators on long panels: (panel_id, channel, ts, value[, observed])."""
