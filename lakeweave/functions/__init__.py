"""Part of lakeweave; see README.md."""
