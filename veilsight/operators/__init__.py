"""DataFrame operators: detection, conversations, findings, coverage and increments."""
