"""Tables, logs and sinks."""
