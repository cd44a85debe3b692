"""DataFrame operators: tokens, events, checks, namespaces, trees, codecs, messages, reports."""
