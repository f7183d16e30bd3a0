"""Row streams over growing folders of files."""
