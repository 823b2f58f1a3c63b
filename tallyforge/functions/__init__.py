"""Part of tallyforge; see README.md."""
