"""CSV intake and result sinks."""
