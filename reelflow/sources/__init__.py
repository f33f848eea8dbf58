"""Tables in, tables out: declared schemas, role views and sinks."""
