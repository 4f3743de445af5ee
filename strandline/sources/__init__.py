"""Reading messy delimited logs, column kinds, and CSV output."""
