"""Tables, files and the views that the queries run on."""
