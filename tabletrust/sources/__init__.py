"""Reading tables and their catalogs, writing copies."""
