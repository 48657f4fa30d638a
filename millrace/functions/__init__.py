"""Part of millrace; see README."""
