"""tracelode: a PySpark-native analytics engine for conversational transcripts and tool-call events."""

__version__ = "0.1.0"
