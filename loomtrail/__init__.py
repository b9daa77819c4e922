"""Part of loomtrail; see README.md."""
