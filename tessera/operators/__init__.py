"""DataFrame -> DataFrame operators over documents, spans, links and postings."""
