"""Part of symloom."""
