"""DataFrame operators over pages, topics, headings, requests and model answers."""
