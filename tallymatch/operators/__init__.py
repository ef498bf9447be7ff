"""DataFrame -> DataFrame operators, composed with ``df.transform`` or plain calls."""
