"""dossier: document-evidence analytics as plain PySpark DataFrame jobs."""
