"""Sources and sinks: page-marked documents, index tables, question banks, run traces."""
