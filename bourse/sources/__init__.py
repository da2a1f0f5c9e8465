"""Tables, files and canonical views."""
