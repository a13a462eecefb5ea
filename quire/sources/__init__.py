"""Sources: directory listings, and blocks out of DOCX, PDF and image files."""
