"""Sources and sinks: what becomes documents, elements and tables, and what they are written as."""
