"""Views, files and tables in the shared folder."""
