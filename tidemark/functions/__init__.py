"""Functions over the metadata of catalogs and views."""
