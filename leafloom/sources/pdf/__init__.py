"""PDF files as tables: a strict reader with repair, a content interpreter, a writer."""
