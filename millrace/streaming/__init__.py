"""Standing work on streams of files: windows, standing queries, captions."""
