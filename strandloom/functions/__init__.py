"""Part of strandloom; see README.md."""
