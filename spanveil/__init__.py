"""Find, score and redact personal data in tables and streams of text, on Spark."""
