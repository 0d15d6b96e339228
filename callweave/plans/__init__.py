"""Where fact tables come from: stored facts, or star-schema tables read as facts."""
