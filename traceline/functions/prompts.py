"""Prompt texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceline.functions.text import fill, is_blank

# The message for a blank file and the two prompt formats, kept
# character for character, trailing blanks included.
EMPTY_FILE_MESSAGE = "Empty file. Please choose another file."

TASK_PROMPT = """You have been asked to perform a specific task related to a codebase. 
    
    Tasks: 
    1) Identify the Purpose of the File: {path} based on Contents of the File below
    - Carefully read through the contents of the provided file. 
    - Summarize what the file is about. Explain the primary functionality or purpose of the code in this file. 
    2) Determine Necessary Changes: 
        - Based on the user's question and the current contents of the file, identify what changes need to be made to accomplish the task specified by the user.
        - Provide a step-by-step outline of the modifications required, including specific code snippets if applicable. 
    Step by Step instruction
    Understanding the File: 
        - Start by examining the file’s structure and content. 
        - Identify key functions, classes, and comments that indicate the purpose and functionality of the file. 
        - Summarize the primary purpose and functionality of the file in a clear and concise manner. 
    Analyzing the User's Question: 
        - Understand the user’s question and the specific task they want to accomplish.
        - Determine how the requested changes align with the current functionality of the file.
    Identifying Changes: 
        - Identify the specific sections of the file that need modification to accomplish the task. 
        - Outline the steps needed to implement these changes, including any new code that needs to be added or existing code that needs to be modified.
        - Provide detailed code snippets for each step, ensuring clarity and correctness.

    Context: 
    User's Question: {query} 
    Top Matching File: {path} 
    Contents of the File: {content} 
        """

SUMMARY_PROMPT = """
            Path: {path}
            Code: 
            {content}
            You response should accomplish following 2 tasks after carefully reading throught the contents of the code pasted above.
            Tasks:
            1. Summarize the code so that a new engineer can understand in 3 lines
            2. Explain what needs to be changed to accomplish the user's task of " {query}" in 2 lines
            """


def task_prompt(query: Column, path: Column, content: Column) -> Column:
    """Long prompt; a blank file gets the fixed message instead."""
    text = fill(TASK_PROMPT, path=path, query=query, content=content)
    return F.when(is_blank(content), F.lit(EMPTY_FILE_MESSAGE)).otherwise(text)


def summary_prompt(query: Column, path: Column, content: Column) -> Column:
    return fill(SUMMARY_PROMPT, path=path, query=query, content=content)
