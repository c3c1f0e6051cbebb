"""Per-ticker window operators and per-date cross-section operators as Columns."""
